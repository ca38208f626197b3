"""The corpus pipeline: quality rules, n-gram Jaccard join, mixing sources to target weights, best-fit packing.

Every stage takes the documents that the stage before it kept and gives back their columns; the last gives the packed
sequences. A document is a row: mixing may repeat rows, and packing packs each of them.

In every stage a null or empty text is a document without words, rows are judged one by one, extra columns are carried
along, and an empty table gives an empty one; the functions that a stage calls state their ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavespark import ship
from wavespark.llm import mixing, near, packing, quality, storage

#: rows in a batch that goes to Python
BATCH = 2000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the label model takes for good. A null or empty text fails them."""
    _ready(spark)
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least doc_id; of several, that with the least hash of its
    shingles, then of the row. Texts without a word all stay."""
    _ready(spark)
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reaches them: not at all, once, or up to three times; in the order of its slots. A null
    source is a source of its own; documents without words are never reached."""
    _ready(spark)
    return mixing.repeat(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a packed sequence; null for a document without words."""
    _ready(spark)
    return packing.best_fit(docs)


def _ready(spark: SparkSession) -> None:
    """Whole documents go to Python: batches are kept short, so that long rows don't fill a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("mix_sources", mix_sources), ("best_fit", best_fit)]
#: expectation-maximisation and MinHash have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.table(docs, name)
    return docs
