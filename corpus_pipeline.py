"""From raw documents to packed token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the documents of the next.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell import ship, store
from terracell.llm import decontamination, mixing, ngram_join, token_ids, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a score of 0.3 or more go; a null text scores as an empty one.  The score is never a column of the result."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return toxicity.score_documents(docs, model, into=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies stays, the one with the smallest id; rows with a null id or without words stay."""
    return ngram_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a benchmark window go, items with a null id included; null and empty texts stay."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a document is there as often as the mix takes it; those without words are never taken."""
    return mixing.take_copies(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the corpus as packed token ids, described from the files; null ids come first, and a null text is an end id."""
    out = store.new_path(spark, "corpus-ids")
    token_ids.write_segments(docs, token_ids.public_vocabulary(), out)
    return token_ids.read_segments(spark, out)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_ids", pack_tokens),
]

#: SQL can express neither the learned scores nor the random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table goes once the next one is written, and the last one's when the application ends."""
    ship.package(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = store.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            store.discard(spark, before)
        before = path
    return docs
