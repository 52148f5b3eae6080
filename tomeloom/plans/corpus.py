"""The driver's tables as a library of books: a book is a source, a page a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores, dealt over all of them.

    Text is worked on before it is ever shuffled, so one small file would keep one core busy;
    a table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, sf_dir: str, book: str = "source") -> DataFrame:
    """(book_key, page, text): pages ascend by document id, so no ranking is needed."""
    docs = spread(table(spark, sf_dir, "documents").select(*dict.fromkeys(["doc_id", "text", book])))
    return docs.select(F.col(book).alias("book_key"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_key, page, idx, text): a page's lines that have text."""
    return pages(spark, sf_dir).select("book_key", "page", F.posexplode(F.split("text", "\n")).alias("idx", "text")).filter("trim(text) <> ''")
