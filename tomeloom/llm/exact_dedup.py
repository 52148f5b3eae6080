"""Exact deduplication by a tree merge of sorted digest runs (DataFrame operations only).

A *run* is a sorted array of entries: a text's 64-bit digest, its SHA-256, the smallest
identifier and a count.  The first runs are stretches of RUN rows of the written digest table.
Then runs meet in binomial rounds: in each, ``fan_in`` neighbours halve their ranges of digests
log2(fan_in) times, exchange the parts, and merge the sorted parts that meet (a sort of sorted
stretches is a merge), so that arrays keep their length while a run's range narrows.  At
every level entries whose digest and SHA-256 are equal become one, with the smallest
identifier; texts whose short digests collide stay apart.  A text that fills a third of the
corpus is one entry a run, and a ``fan_in``-th of that in each later round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.store import small_join, two_hop_join, written

KEYS = ["digest", "sha"]
#: Rows of a first run.
RUN_BITS = 13


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space (x20, x09-x0D) becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _verified(runs: DataFrame) -> DataFrame:
    """Sorted arrays ``m`` with equal entries made one: the first, which has the smallest identifier."""
    last = F.size("m") - 1

    def begins(i: Column) -> Column:
        own, before = F.col("m")[i], F.col("m")[i - 1]
        return (i == 0) | (own["digest"] != before["digest"]) | (own["sha"] != before["sha"])

    runs = runs.withColumn("starts", F.filter(F.sequence(F.lit(0), last), begins))

    def entry(s: Column, j: Column) -> Column:
        first, end = F.col("m")[s], F.coalesce(F.get("starts", j + 1), F.size("m"))
        n = F.when(end == s + 1, first["n"]).otherwise(F.aggregate(F.slice("m", s + 1, end - s), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        return F.struct(*[first[c].alias(c) for c in (*KEYS, "none", "id", "row")], n.alias("n"))

    # most runs of digests have no equal neighbours, and stay what they are
    return runs.withColumn("m", F.when(F.size("starts") > last, F.col("m")).otherwise(F.transform("starts", entry))).drop("starts")


def _exchanged(runs: DataFrame, fan_in: int, narrowed: int) -> DataFrame:
    """Each run's parts by the next bits of the digest (``narrowed`` are used already), met with its neighbours'."""
    bits = fan_in.bit_length() - 1

    def part(j: Column) -> Column:
        mine = F.filter("m", lambda x: F.shiftrightunsigned(x["digest"], 64 - narrowed - bits).bitwiseAND(F.lit(fan_in - 1)) == j)
        return F.struct(j.alias("j"), mine.alias("m"))

    parts = runs.select("run", "segment", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fan_in - 1)), part)).alias("p")).filter(F.size("p.m") > 0)
    met = parts.groupBy(F.floor(F.col("run") / fan_in).alias("run"), (F.col("segment") * fan_in + F.col("p.j")).alias("segment"))
    return _verified(met.agg(F.array_sort(F.flatten(F.collect_list("p.m"))).alias("m")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, run_bits: int = RUN_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    * null text counts as empty; an empty or blank-only text is a text like any other;
    * of equal texts the smallest id stays; a null id counts as larger than any other;
    * of repeated rows (same id, equal text) exactly one is kept;
    * an empty table gives an empty result; other columns, whatever their names, are unread.
    """
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in: a power of two")
    text = normalised(F.col(text_col))
    row = F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.xxhash64("t").alias("digest"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.spark_partition_id().alias("run"),
        row.alias("row"),
    )
    base = written(base, "digests")
    # a partition's rows are numbered from its number times 2^33
    place = F.shiftright(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)), run_bits)
    parts, longest = base.agg(F.max("run"), F.max(place)).first()
    stretches = (longest or 0) + 1
    runs = ((parts or 0) + 1) * stretches
    entry = F.struct(*KEYS, F.col("id").isNull().alias("none"), "id", "row", F.lit(1).cast("long").alias("n"))
    level = base.groupBy((F.col("run") * F.lit(stretches) + place).alias("run")).agg(F.array_sort(F.collect_list(entry)).alias("m"))
    level = _verified(level.withColumn("segment", F.lit(0).cast("long")))
    narrowed = 0
    while runs > 1:
        level = _exchanged(level, fan_in, narrowed)
        narrowed += fan_in.bit_length() - 1
        runs = -(-runs // fan_in)
    # one run is left, in segments: texts that occur once need no way back down
    groups = level.select(F.explode(F.filter("m", lambda x: x["n"] > 1)).alias("e")).select(*[F.col(f"e.{c}").alias(c) for c in KEYS], F.col("e.id").alias("keep_id"), F.col("e.row").alias("keep_row"), "e.n")
    out = two_hop_join(base, groups, "run", KEYS)
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all its columns unchanged.

    Of rows with the kept row's id and an equal text, but other columns, any one may stay.
    """
    groups = written(exact_groups(docs, id_col, text_col).filter("group_size > 1"), "groups")
    gone = groups.filter("not kept").select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha"))
    stays = groups.filter("kept").select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha"))
    node = [F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha")]
    rows = docs.select(F.struct("*").alias("doc"), *node)
    # an id and text that both stays and goes is a row given twice
    twice = written(gone.join(stays, gone.id.eqNullSafe(stays.id) & (gone.sha == stays.sha), "left_semi").distinct(), "given-twice")
    out = small_join(rows, written(gone.distinct(), "gone"), ["id", "sha"], "left_anti", salts=1)
    if twice.limit(1).count():
        out = out.unionByName(small_join(rows, twice, ["id", "sha"], "left_semi", salts=1).dropDuplicates(["id", "sha"]))
    return out.select("doc.*")
