"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_label(rows: DataFrame, label: str, most: int, seed: int = 5) -> DataFrame:
    """Rows with a further column share: min(most, n) of the n rows of each label, and that share of n.

    The sample is the least hashes of whole rows, so that it does not depend on partitioning, on ids being there
    or on their being different; of rows that are equal throughout any may be taken. Rows with a null label are
    left out. A count a label, of which callers let in no more than 2,000, is broadcast, so that rows are thinned by
    hash where they are read and only the twofold sample is dealt by label and ranked.
    """
    rows = rows.where(F.col(label).isNotNull())
    hashed = rows.withColumn("_draw", F.xxhash64(F.lit(seed), *rows.columns))
    counts = hashed.groupBy(label).agg(F.count("*").alias("_n"), F.approx_count_distinct("_draw").alias("_different"))
    below = F.least(F.lit(1.0), (2.0 * most + 100) / F.col("_different"))
    near = hashed.join(F.broadcast(counts), label).where(F.pmod("_draw", F.lit(1 << 20)) < below * (1 << 20))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_draw"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).select(*rows.columns, F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n")).alias("share"))


def labelled(docs: DataFrame, labels: DataFrame, marks: list, label: str, most: int, most_chars: int = 64_000_000) -> DataFrame:
    """doc_id, text, the marks and share for a sample of at most `most` documents of each value of a label.

    docs: doc_id, text; labels: doc_id and what marks (aggregates over the rows that repeat a doc_id) need. Of
    documents that repeat an id the least text counts; documents beyond most_chars characters of a label together
    are left out.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*marks).where(F.col(label).isin(0, 1))
    picked = per_label(known, label, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * most rows at most
    rest = [c for c in picked.columns if c != "doc_id"]
    rows = rows.groupBy("doc_id", *rest).agg(F.min("text").alias("text"))
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.withColumn("_chars", chars).where(F.col("_chars") <= most_chars).select("doc_id", "text", *rest)
