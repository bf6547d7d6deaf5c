"""Bounded samples of labelled documents, for what is fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 1 << 40


def held_out(doc_id: str) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int) -> DataFrame:
    """(doc_id, text, grade): about ``per_grade`` documents of each grade, in the order of a hash of doc_id.

    ``grade`` is an integer column over ``labels`` with few values. Labels with
    a null grade or doc_id teach nothing; of several labels of a document the
    highest grade holds; rows of ``docs`` that repeat a doc_id all get it, with whatever text they have. The drawn ids number about per_grade for each grade, so they are
    broadcast and the texts stay where they are.
    """
    graded = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), grade.cast("int").alias("grade")).filter("grade is not null").groupBy("_id").agg(F.max("grade").alias("grade"))
    graded = graded.withColumn("draw", F.pmod(F.xxhash64("_id"), F.lit(SPREAD)))
    sizes = graded.groupBy("grade").count().collect()
    if not sizes:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).alias("grade")).limit(0)
    chance = F.lit(False)
    for g, n in sizes:
        chance = chance | ((F.col("grade") == g) & (F.col("draw") < int(min(1.0, per_grade / n) * SPREAD)))
    drawn = graded.filter(chance).select("_id", "grade")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return plain.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "grade")
