"""Queries over streams and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeloom.plans.corpus import table
from tomeloom.plans.terms import COUNTS, GRAMS, STOP, _BASE
from tomeloom.sources import readers
from tomeloom.sources.tables import shared_dir, written
from tomeloom.streaming import incremental


def ndjson_fold(spark, sf_dir):
    """SRC17, STR07: turns as event lines, folded to one answer a conversation."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    line = F.to_json(F.struct(F.lit("delta").alias("type"), F.struct(F.col("text")).alias("delta")))
    lines = c.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("long").alias("seq"), line.alias("line"))
    out = readers.fold_events(readers.assistant_events(lines.unionByName(spark.createDataFrame([("0", 99, "not json")], "stream_id string, seq long, line string"))))
    return out.select("stream_id", F.md5(F.col("answer").cast("binary")).alias("answer"))


def stream_term_counts(spark, sf_dir):
    """STR01: the miner's counts as a file stream leaves them."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    # three batches, each of as many files as keep all cores busy: a file is read by few tasks
    files = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    docs.repartition(3 * files).write.parquet(f"{base}/in")
    counts = incremental.stream_ngram_counts(incremental.stream_pages(spark, f"{base}/in", files=files), STOP.func)
    sums = {}

    def keep(batch, number):
        # a batch that is run again takes the place of its first run
        sums[number] = written(incremental.summed_counts(batch), f"batch-{number}")

    incremental.run_to_end(counts, f"{base}/checkpoint", keep, mode="append")
    all_sums = reduce(DataFrame.unionByName, sums.values())
    return written(incremental.summed_counts(all_sums).filter("freq >= 3"), "counts").select("book_key", "key", "n", "freq", "non_init")


QUERIES = {"ndjson_fold": ndjson_fold, "stream_term_counts": stream_term_counts}
ORACLE = {
    "ndjson_fold": "SELECT CAST(conv_id AS VARCHAR) AS stream_id, md5(string_agg(text, '' ORDER BY turn)) AS answer FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
    "stream_term_counts": f"{_BASE}, {GRAMS}, {COUNTS} SELECT book_key, key, n, freq, non_init FROM counts_ WHERE freq >= 3",
}
