"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from pixelmill.llm.common import cut, scratch_dir, table
from pixelmill.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Similarity in percent from which the near-dedup stage links; op2's own threshold is fixed by its contract.
NEAR = 80
#: Ids up to which the documents to leave out are broadcast, about 100 MB as a hash table; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among ``ids``; rows without an id stay. The ids are written and counted first, so that texts are shuffled for more than BROADCAST_IDS only."""
    ids = cut(ids.select("doc_id").distinct())
    small = ids.count() <= BROADCAST_IDS
    return docs.select(*COLUMNS).join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that the toxicity model predicts as toxic; rows without an id are kept."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score(docs, model).filter("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near duplicates, linked at NEAR percent."""
    return _without(docs, near_dedup.near_duplicates(docs, percent=NEAR).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item."""
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mix takes it (0 to 3 times), rows without an id or source too.

    Rows are known by 128 hashed bits of all their columns; rows that agree in all
    columns are alike, and together come as often as the mix takes them.
    """
    cells = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]
    rows = docs.select(*COLUMNS).withColumns({"row1": F.xxhash64(F.lit(1), *cells), "row2": F.xxhash64(F.lit(2), *cells)})
    taken = mixing.copies(rows, row=("row1", "row2")).groupBy("row1", "row2").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    once = rows.groupBy("row1", "row2").agg(F.first(F.struct(*COLUMNS)).alias("doc")).join(taken, ["row1", "row2"])
    return once.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, kept, and what they hold when read back.

    They go to a folder of their own under spark.pixelmill.tokens.dir, or under the
    shared scratch folder where it isn't set; the log names it.
    """
    base = spark.conf.get("spark.pixelmill.tokens.dir", None)
    path = f"{base.rstrip('/')}/tokens-{uuid.uuid4().hex}" if base else f"{scratch_dir(spark)}-tokens"
    files = token_files.write_tokens(docs, vocabulary_path(), path)
    logging.getLogger(__name__).info("token files: %s", files.path)
    return token_files.read_tokens(spark, files)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: SQL can't express the trained, hashed and randomised stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
