"""The corpus pipeline: documents in, tokenised documents out. Each stage calls one operator of ``mixclust.llm``;
its result is written as Parquet and read back as the next stage's documents.

Rows with a null doc_id go through all stages; of the columns only COLUMNS are read and returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixclust.llm.decontaminate import clean
from mixclust.llm.near_dedup import near_components
from mixclust.llm.quality import learn, score
from mixclust.llm.sentencepiece_bpe import tokenise
from mixclust.llm.substring_dedup import cut_repeats
from mixclust.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR = 0.8
MOST_BROADCAST = 500_000  # rows of an id and a hash; more are shuffled


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity NEAR or more, over any number of links) the document with the
    smallest id. Different texts of one id are documents of their own: the one of least hash has the id in
    that comparison, the others come after all ids. Of rows with equal id and text one stays, the least in the other
    columns; rows without an id all stay."""
    docs = docs.select(*COLUMNS)
    text_hash = F.xxhash64("text")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(text_hash).alias("first")).where("n > 1")
    repeated = written(repeated.select("doc_id", "first"), "repeated-ids")
    known, n = docs.where("doc_id is not null"), repeated.count()
    if n == 0:
        known = known.withColumn("first", F.lit(None).cast("long"))
    else:
        known = known.join(F.broadcast(repeated) if n <= MOST_BROADCAST else repeated, "doc_id", "left")
    other = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    known = known.withColumn("own", F.when(F.col("first").isNull() | (F.col("first") == text_hash), F.col("doc_id")).otherwise(other))
    kept = near_components(known.select(F.col("own").alias("doc_id"), "text"), NEAR).where("kept").select(F.col("doc_id").alias("own")).distinct()
    known = known.join(kept, "own", "left_semi")
    once = known.where("first is null").select(*COLUMNS)
    least = known.where("first is not null").groupBy("own").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.unionByName(least).unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that are also in a document with a smaller id go. Words that stay
    are joined by one space; a document without repeats keeps its text as it is."""
    cut = cut_repeats(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that matches a benchmark item."""
    return clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and of the text that they decode to."""
    return tokenise(docs, outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL: a fitted classifier, links found by sketches and a tokenizer are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
