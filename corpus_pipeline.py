"""From raw documents to packed training sequences, in five stages that each write a whole table.

Every stage but the last takes and returns the columns of ``documents``; the last returns pieces with their places.
Rows with a null id are neither rejected nor taken for near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.llm import jaccard, mixing, packing, quality, repeats
from loquent.llm.common import materialize, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, judged.filter("not kept")).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays; rows that repeat an id stay once."""
    classes = jaccard.similar(docs)
    kept = without(docs, classes.filter("doc_id <> class_id")).select(COLUMNS)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeated:
        least = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        kept = least.select("doc_id", "row.*").unionByName(kept.filter("doc_id is null"))
    return kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 50 bytes that an earlier document has go; texts may end up empty."""
    cut = repeats.dedup(docs, carry=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emit(mixing.mix(docs)).select(COLUMNS)


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in sequences of 1024."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_pieces),
]

#: SQL can't express minimum-hash joins, byte-level repeats and packing; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
