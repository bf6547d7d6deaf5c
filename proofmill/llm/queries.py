"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=40)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    docs = read(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("digests",))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeat_digests

    return repeat_digests(read(spark, sf_dir, "documents"), length=100).drop("spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import grade_documents, learn
    from .sampling import held_out

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(~held_out("doc_id")))
    return grade_documents(docs, model).withColumn("held_out", held_out("doc_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import held_out
    from .toxicity import learn, score_documents

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(~held_out("doc_id")))
    return score_documents(docs, model, with_passages=False).withColumn("held_out", held_out("doc_id"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    docs = read(spark, sf_dir, "documents")
    return scan(docs, stand_in_path(docs))


def stand_in_path(docs: DataFrame) -> Column:
    """Documents have no paths. Runs of doc_ids are directories: 4096 make a tree, 256 a package, 16 a folder; the first file of each package and folder is named LICENSE."""
    from pyspark.sql import functions as F

    of = lambda n: F.expr(f"cast(floor(doc_id / {n}) as string)")
    name = F.coalesce(docs["doc_id"].cast("string"), F.lit("none"))
    tree, package, folder = F.concat(F.lit("t"), of(4096)), F.concat(F.lit("p"), of(256)), F.concat(F.lit("f"), of(16))
    return (
        F.when(docs["doc_id"] % 256 == 0, F.concat_ws("/", tree, package, F.lit("LICENSE")))
        .when(docs["doc_id"] % 16 == 0, F.concat_ws("/", tree, package, folder, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", tree, package, folder, name))
    )


def licence_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over trees with whole licence files: hosts are trees, languages folders, web pages files; each host has a LICENSE, one folder in three a COPYING of its own.

    Which licence it is depends on the host's name and the folder's. Its text stands behind a copyright line.
    """
    from pyspark.sql import functions as F

    from .licenses import FILES, WHOLE, scan

    texts = spark.createDataFrame([(k, dict(FILES[-len(WHOLE):])[name]) for k, name in enumerate(WHOLE)], "k int, licence_text string")
    place = F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.regexp_extract("url", "//[^/]*/([a-z]*)", 1).alias("folder")
    files = read(spark, sf_dir, "pages").select(*place, F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    index = lambda c: F.pmod(F.length(c) * 7 + F.ascii(c), F.lit(len(WHOLE))).cast("int")
    roots = files.select(F.concat("host", F.lit("/LICENSE")).alias("path"), index("host").alias("k"), "host").distinct()
    inner = files.filter("folder <> '' and (length(host) + ascii(folder)) % 3 = 0").select(F.concat_ws("/", "host", "folder", F.lit("COPYING")).alias("path"), index(F.concat("folder", "host")).alias("k"), "host").distinct()
    licences = roots.unionByName(inner).join(F.broadcast(texts), "k").select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("Copyright (c) 2020 "), "host", F.lit("\n\n"), "licence_text").alias("text"), "path")
    all_files = files.select("doc_id", "text", F.concat_ws("/", "host", "folder", F.col("doc_id").cast("string")).alias("path")).unionByName(licences)
    return scan(all_files, all_files["path"]).select("path", "licence", "how", "licence_dir")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn, predict
    from .sampling import held_out

    docs = read(spark, sf_dir, "documents")
    models = learn(docs.filter(~held_out("doc_id")))
    return predict(docs, models).withColumn("held_out", held_out("doc_id"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), words=2, num=80, den=100)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metricjoin import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"), words=5, num=80, den=100)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), num=10, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_sharding": op2_sharding, "op3_bpe": op3_bpe, "op4_suffix_dedup": op4_suffix_dedup, "op5_quality": op5_quality, "op6_licenses": op6_licenses, "op7_language": op7_language, "op8_toxicity": op8_toxicity, "op9_near_duplicates": op9_near_duplicates, "op10_quality_rules": op10_quality_rules, "op11_jaccard_join": op11_jaccard_join, "op12_spelling_variants": op12_spelling_variants, "op13_resampling": op13_resampling, "licence_trees": licence_trees}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES
