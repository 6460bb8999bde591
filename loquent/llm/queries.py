"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.llm import graphs, jaccard, media, mixing, packing, quality, ranked, recurrent, repeats, spelling, token_counts, topk, toxicity
from loquent.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), threshold=0.8, n=5)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.dedup(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["begin"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=1024, end_id=2)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = materialize(media.media_table(table(spark, sf_dir, "documents")))  # written once; what follows reads the stored bytes
    facts = materialize(media.read_back(held))  # its size is known then, and so are partitions to split
    found = media.resolve(media.sequences(media.document_pages(held), "doc_id"), facts, "doc_id")
    found = found.filter(F.col("digest").isNotNull())
    n_bytes = F.regexp_extract("text", r"^(\d+) bytes$", 1).cast("long").alias("n_bytes")
    return found.select("doc_id", n_bytes, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents"))
    counted = counted.select("doc_id", "n_bytes", token_counts.total().alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return found.withColumnRenamed("item", "item_id")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_packing": op6_packing,
    "op7_media": op7_media,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_nearest": op12_nearest,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op5_topk": topk.SQL,
    "op11_ranked_search": ranked.SQL,
    "op4_mixing": mixing.SQL.format(docs="documents") + """
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM rated
""",
}
