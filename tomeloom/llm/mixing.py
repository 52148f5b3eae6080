"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame operations only).

A document's key is ``-ln(u) / w``: u in (0, 1] from a digest of its identifier, w its
quality weight.  A source's budget is met by as many complete epochs as fit, then by its
documents in key order up to the rest.  That order is never sorted as a whole: keys fall in
buckets by a monotone function, bucket sums give the one bucket in which the budget ends,
and only that bucket's rows are sorted and prefix-summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.llm.store import small_join, written

WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column, words: Column) -> Column:
    """From 0.25 (no sentence ends) to 1 (a sentence end for each 25 words or fewer)."""
    ends = F.length(text) - F.length(F.translate(text, ".!?", ""))
    return F.when(words > 0, 0.25 + 0.75 * F.least(F.lit(1.0), 25.0 * ends / words)).otherwise(F.lit(0.25))


def uniform(ident: Column) -> Column:
    """In (0, 1], from the first 52 bits of the identifier's MD5: the same on every run."""
    return (F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """sources (source, source_size, n) with target: shares by weight of all sizes, none above
    ``cap`` times its source; what a source cannot take is reshared until none is above.

    Weights repeat over the sources in code-point order, null last.  The level at which the
    shares settle is read off the sources in order of cap per weight.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.select("*", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - full) / rest)
    settled = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True)
    rows = rows.withColumn("level", settled.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digest: Column | None = None
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, epochs, cut (and digest, if given).

    ``taken = epochs * size + cut``: that many complete copies, and the first ``cut`` words
    of one more (``cut = size`` for a document selected whole).

    * null text: size 0, nothing taken; null source: a source of its own, last in order;
    * equal keys are ordered by id, then by the row's place in the written table;
    * an empty table, or one whose texts are all empty, takes nothing;
    * sources are the units of a mixture that someone weighs; their one small table is
      ordered in one task, while documents never are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.lit(None).cast("long") if digest is None else digest).alias("digest"), text.alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    key = -F.log(uniform(F.col("id"))) / quality_weight(F.col("t"), F.col("size"))
    base = written(base.select("id", "digest", "source", "size", key.alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = written(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    # buckets: a power of two that leaves some thousand rows of the largest source in each
    most = sources.agg(F.max("n")).first()[0] or 0
    buckets = 256
    while buckets < 65_536 and most > 4096 * buckets:
        buckets *= 2
    # monotone in key; 0.7 is about the mean weight, which spreads the buckets evenly
    bucket = F.floor(buckets * (1.0 - F.exp(-0.7 * F.col("key")))).cast("int")
    plan = targets(sources, weights, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")).select("source", "source_size", "target", "epochs", "rest")
    sums = base.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    ends = small_join(sums.withColumn("before", before), written(plan, "plan"), ["source"])
    last = F.max(F.when(F.col("before") < F.col("rest"), F.struct("bucket", "before")))
    ends = ends.groupBy("source", "source_size", "target", "epochs", "rest").agg(last.alias("last"))
    ends = written(ends.select("source", "source_size", "target", "epochs", "rest", F.coalesce("last.bucket", F.lit(-1)).alias("last"), F.coalesce("last.before", F.lit(0)).cast("long").alias("base")), "ends")
    rows = small_join(base.withColumn("bucket", bucket), ends, ["source"])
    inside = F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    edge = rows.filter("bucket = last").withColumn("left", F.col("rest") - F.col("base") - inside)
    edge = edge.withColumn("cut", F.greatest(F.lit(0), F.least("size", "left")))
    others = rows.filter("bucket <> last").withColumn("left", F.lit(0).cast("long"))
    others = others.withColumn("cut", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0))
    out = others.unionByName(edge)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs", F.col("cut").cast("long").alias("cut"),
        *([] if digest is None else ["digest"]),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each complete copy, and the first words of a cut one.

    * columns stay; n_chars, where there is one, follows the text;
    * rows with one id and different contents are taken each for itself; copies planned for
      rows that are equal in all columns are made of one of them;
    * null and empty texts have no words to take and go; null sources and ids stay what they are.
    """
    # what tells rows of one id apart; maps have no digest
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    part = F.when(F.col("cut") > 0, F.array("cut")).otherwise(F.array().cast("array<bigint>"))
    plan = mix(docs, weights, cap, id_col, text_col, source_col, whole).filter("taken > 0")
    plan = plan.select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), F.col("size").alias("_size"), F.concat(F.array_repeat("size", F.col("epochs").cast("int")), part).alias("_copies"))
    plan = written(plan.groupBy("_id", "_digest", "_size").agg(F.flatten(F.collect_list("_copies")).alias("_copies"), F.count(F.lit(1)).alias("_rows")), "copies")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), whole.alias("digest"))
    if plan.filter("_rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "digest"])
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "inner").withColumn("words", F.explode("_copies"))
    text = F.col(f"doc.{text_col}")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("_size"), first).otherwise(text))
    put = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[put.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
