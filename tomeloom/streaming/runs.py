"""Runs of a build: which books are due, in what order, and what a finished run leaves.

The queue is a table that follows from requests and shards, so a run that died is due again as
it was, and one that finished is not: jobs are known by (path, generation, stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINGER_MS = 20_000


def build_queue(requests: DataFrame, shards: DataFrame, generation: int) -> DataFrame:
    """(path, at, stage) in order of ``at``: what requests (path, at, action: build, force, forget)
    and shards (path, stage, gen) leave to do.

    Of one path's requests the last decides and the first since a forget places it; a forced
    build is due whatever there is, any other if the shard is missing, not deep, or older than
    ``generation``.  A seed of this generation has only its deep stage to do.
    """
    last = F.max_by("action", "at").alias("action")
    forgot = F.max(F.when(F.col("action") == "forget", F.col("at"))).alias("forgot")
    each = requests.groupBy("path").agg(last, forgot)
    live = requests.join(each.select("path", "forgot"), "path").filter(F.col("forgot").isNull() | (F.col("at") > F.col("forgot")))
    first = live.groupBy("path").agg(F.min("at").alias("at"), F.bool_or(F.col("action") == "force").alias("forced"))
    rows = each.filter("action <> 'forget'").join(first, "path").join(shards.select("path", F.col("stage").alias("have"), "gen"), "path", "left")
    old = F.col("have").isNull() | (F.col("gen") < generation)
    due = F.col("forced") | old | (F.col("have") != "deep")
    stage = F.when(F.col("forced") | old, "seed").otherwise("deep")
    return rows.filter(due).select("path", "at", stage.alias("stage")).orderBy("at", "path")


def finished(queue: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """(path, state): results (path, ok, at) of a queue's jobs as a reader sees them: done at once, failed
    for as long as failures linger, else waiting."""
    rows = queue.select("path").join(results, "path", "left")
    state = F.when(F.col("ok"), "done").when(~F.col("ok") & (F.lit(now) - F.col("at") <= LINGER_MS), "failed").when(F.col("ok").isNull(), "waiting")
    return rows.select("path", state.alias("state")).filter("state is not null")
