"""From documents to packed token sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of
``documents``.

1. toxicity: documents that the ordinal model rejects go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8 or more)
   the document with the least id stays, and of repeated rows one.
3. decontamination: documents in which a benchmark window of ten words occurs go.
4. secrets: spans found are masked in the text; ``n_chars`` follows.
5. packing: pieces of token ids in sequences of at most 2048.

Stage 2 sends the ids that go, or occur again, to the texts; only texts whose id occurs again are
shuffled. (Of more than ``links.FEW_NODES`` such ids, the texts meet them in a shuffle.)

Rows with a null id are kept by stage 2; a null text passes all stages and is packed as empty.
Empty tables pass through. Other columns of ``documents`` are carried to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, links, neardup, packing, secrets, toxicity
from tidemark.llm.common import table
from tidemark.session import pin


#: Rows of one Arrow batch. Whole texts lie in it, on both sides of the pipe to Python, beside the heap.
BATCH = 2_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    grouped = neardup.group(docs, shingle=5, percent=80, bands=38, rows=5)
    ids = grouped.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    apart = pin(ids.where("not kept or n > 1"))
    few = apart.count() <= links.FEW_NODES
    listed = lambda rows: F.broadcast(rows.select("doc_id")) if few else rows.select("doc_id")
    out = docs.join(listed(apart), "doc_id", "left_anti")
    if not (repeated := apart.where("kept")).isEmpty():
        out = out.unionByName(docs.join(listed(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, packing.vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: A trained model decides in the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else pin(docs)
    return docs
